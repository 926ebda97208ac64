"""Sum-of-squares packing, the filter audit and spelling variants against brute force on small tables."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from codexloom.llm import best_fit, filter_audit, queries, spelling
from codexloom.llm.common import Work
from tests.compare import duck
from tests.compare import rows as shaped
from tests.llm.test_small import ROWS

RNG = random.Random(31)
CLASHES = ", ".join(f"`{c}` double" for c in ("part", "row", "n", "group", "length", "piece", "word", "form", "mask", "class", "text_"))


def frame(spark, rows):
    """Rows of (doc_id, text) with columns of clashing names."""
    k = CLASHES.count("double")
    return spark.createDataFrame([(*r, *[1.0] * k) for r in rows], f"doc_id long, text string, {CLASHES}")


# 11


def library(text):
    from tokenizers import Tokenizer

    t = library.__dict__.setdefault("t", Tokenizer.from_file(P.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_best_fit_against_the_library(spark):
    rows = [(i, t) for i, t, *_ in ROWS] + [(5, "one two"), (5, "one two"), (None, "x y"), (7, " ".join(f"w{i}" for i in range(9000))), (8, None), (9, "")]
    rows += [(100 + i, "the cat sat " * RNG.randrange(1, 900)) for i in range(300)]
    ids = best_fit.encode(frame(spark, rows).repartition(5), P.path("byte_bpe_50k.json"), 0, Work(spark, "t"))
    pieces = [r.asDict() for r in best_fit.pack(ids, group=64).collect()]
    want = sorted((-1 if i is None else i, tuple([*library(t), 0])) for i, t in rows)
    docs, bins = defaultdict(list), defaultdict(list)
    for r in pieces:
        docs[r["doc_id"], r["part"], r["row"]].append(r)
        bins[r["sequence_id"]].append(r)
    stored = {(r.part, r.row): np.frombuffer(r.ids, f"<u{r.width}").astype("<u4") for r in ids.collect()}
    got = []
    for (doc, part, row), own in docs.items():
        own.sort(key=lambda r: r["piece"])
        data, at = stored[part, row], 0
        for k, r in enumerate(own):
            assert r["piece"] == k and r["start"] == at and 1 <= r["length"] <= 2048 and (k == 0 or r["length"] == 2048)
            assert r["ids_crc32"] == zlib.crc32(data[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(data) and (len(own) == 1 or len(data) > 2048)
        got.append((-1 if doc is None else doc, tuple(data.tolist())))
    assert sorted(got) == want
    for own in bins.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [0, *itertools.accumulate(r["length"] for r in own[:-1])] and sum(r["length"] for r in own) <= 2048
    total = sum(len(x) for x in stored.values())
    assert len(bins) <= total / 2048 * 1.02 + len(rows) / 64 + 1
    for r in best_fit.sequences(ids, best_fit.pack(ids, group=64)).collect():
        own = bins[r.sequence_id]
        assert r.ids == [int(x) for p in own for x in stored[p["part"], p["row"]][p["start"] : p["start"] + p["length"]]]
        assert [(p.doc_id, p.piece, p.offset, p.length) for p in r.pieces] == [(p["doc_id"], p["piece"], p["offset"], p["length"]) for p in own]
    empty = best_fit.encode(frame(spark, []), P.path("byte_bpe_50k.json"), 0, Work(spark, "t"))
    assert best_fit.pack(empty).count() == 0 and best_fit.sequences(empty, best_fit.pack(empty)).count() == 0


def slow_place(lengths, window):
    """The rule written out: of open sequences with room, that after which the sum of squares is least, then the fullest."""
    gaps, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[i]
        fits = []
        for g in {g for g in gaps if g >= size}:
            after = Counter(x for x in gaps if x)
            after[g] -= 1
            if g > size:
                after[g - size] += 1
            fits.append((sum(v * v for v in after.values()), g))
        gap = min(fits)[1] if fits else window
        if fits:
            gaps.remove(gap)
        gaps.append(gap - size)
        out[i] = window - gap
    return out, len(gaps)


def test_place_follows_the_sum_of_squares():
    for _ in range(60):
        window = RNG.choice([5, 12, 40])
        lengths = [RNG.randrange(1, window) for _ in range(RNG.randrange(0, 60))]
        sequence, offset = best_fit.place(lengths, window)
        want, begun = slow_place(lengths, window)
        assert dict(enumerate(offset.tolist())) == want and len(set(sequence.tolist())) == begun
    assert best_fit.cut(1, 8) == [0, 1] and best_fit.cut(8, 8) == [0, 8] and best_fit.cut(19, 8) == [0, 3, 11, 19]


def test_best_fit_fills_sequences(spark):
    """On the driver's documents: no more sequences than the lower bound and one for each group."""
    d = "/root/testdata/sf0.01"
    rows = queries.op11_best_fit(spark, d).collect()
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 2048) + 1 + len(rows) // 512
    assert len({r.doc_id for r in rows}) == spark.read.parquet(f"{d}/documents.parquet").count()


# 12


def brute_audit(rows, labels):
    """From the contract, document by document: rows of (doc_id, text, lang)."""
    import re

    quality, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    failed = []
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and least[t] < i]
        failed.append((lang or "", {f for f, x in zip("ABCDE", tests, strict=True) if x}, i in quality, i in toxic))
    out, share = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {x[0] for x in failed}:
            own = [x for x in failed if x[0] == part]
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [x for x in own if f in x[1] and not x[1] & before]
                share[part, f] += len(gone)
                out[part, order, step] = [sum(not x[1] & (before | {f}) for x in own), len(gone), sum(f in x[1] and bool(x[1] & before) for x in own), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows():
    word = lambda: "".join(RNG.choice("abcdefg") for _ in range(3))
    rows = [(i, t, ["en", "de", None][k % 3]) for k, (i, t, *_) in enumerate(ROWS)]
    for i in range(200, 260):
        t = " ".join(word() for _ in range(RNG.choice([5, 199, 200, 201, 400])))
        rows.append((i, RNG.choice([t, t.upper(), t + " #", t.replace("a", "A"), "\u00a0".join(t.split(" ")), "\x0b" + t + "\x1f"]), RNG.choice(["en", "fr", ""])))
    rows += [(300 + i, rows[RNG.randrange(len(rows))][1], "en") for i in range(40)]  # copies
    long = "x" * 30_000
    rows += [(400, long + "a", "en"), (401, long + "b", "en"), (402, long + "a", "fr"), (402, long + "a", "fr"), (402, "other", "fr"), (None, "other", None), (None, None, None), (403, "", "en"), (404, None, "en")]
    return rows


LABELS = [(i, i % 2, i % 3 % 2) for i in range(0, 420, 2)] + [(402, 0, 0), (402, 1, 1), (None, 1, 1), (300, None, None)]


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda x: F.lit(7).cast("long")])
def test_audit_against_brute_force(spark, hashed, monkeypatch):
    """Also with hashes that always collide: then classes hold several texts and the texts decide."""
    rows = audit_rows()
    docs = spark.createDataFrame([(*r, 1.0, 2.0, 3.0) for r in rows], "doc_id long, text string, lang string, mask double, part double, class double")
    labels = spark.createDataFrame([(*r, 5) for r in LABELS], "doc_id long, quality int, toxic int, part int")
    masks = filter_audit.masks
    monkeypatch.setattr(filter_audit, "masks", lambda d, w, p: masks(d, w, p, hashed))
    got = filter_audit.audit(docs, labels, Work(spark, "t")).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == brute_audit(rows, LABELS) and len(got) == 600 * len({r[2] or "" for r in rows})
    assert filter_audit.audit(docs.limit(0), labels, Work(spark, "t")).count() == 0


def test_refinement_drops_what_differs_in_any_block(spark):
    """Same length and head, another tail: classes fall apart in the round of that block."""
    head = "".join(RNG.choice("abcdefé") for _ in range(6000))
    rows = [(1, head + "a"), (2, head + "b"), (3, head + "a"), (4, head[:-1] + "zz"), (5, "same"), (6, "same"), (7, "diff"), (8, None), (9, "")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    known = filter_audit.described(docs).cache()
    left = filter_audit.refined(known, Work(spark, "t"))
    assert {r.doc_id for r in known.join(left, "class", "left_semi").collect()} == {1, 3, 5, 6, 8, 9}
    assert {r.doc_id: r.mask >> 4 for r in filter_audit.masks(docs, Work(spark, "t")).collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 1, 7: 0, 8: 0, 9: 1}


def test_audit_against_sql(spark):
    d = "/root/testdata/sf0.001"
    df = queries.op12_filter_audit(spark, d)
    names, want = duck(d, filter_audit.SQL)
    assert sorted(names) == sorted(df.columns) and shaped(df.columns, [tuple(r) for r in df.collect()]) == shaped(names, want)


# 13


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    import re

    total = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def brute_variants(words):
    near = {w: [u for u in words if one_edit(w, u)] for w in words}
    form = {}
    for w, us in near.items():
        best = min(us, key=lambda u: (-words[u], u), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def by_word(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_spelling_against_brute_force(spark):
    letters = "abAÀßéÿ×"
    base = ["".join(RNG.choice(letters) for _ in range(RNG.choice([4, 5, 5, 6, 6, 7, 8]))) for _ in range(160)]
    texts = []
    for _ in range(500):
        w = RNG.choice(base[: RNG.choice([5, 40, 160])])
        k = RNG.randrange(len(w))
        w = RNG.choice([w, w, w[:k] + w[k + 1 :], w[:k] + RNG.choice(letters) + w[k:], w[:k] + RNG.choice(letters) + w[k + 1 :]])
        texts.append(RNG.choice([" ", "1", "Ā", "-"]).join([w] * RNG.choice([1, 3, 7])))
    rows = list(enumerate(texts)) + [(None, base[0] + " " + base[1]), (None, None), (7, ""), (7, "aaaaaa aaaaaa aaaaaa aaaaaaa aaaaaaa aaaaaaa aaaaa aaaaa aaaaa"), (8, "x" * 3000 + " "), (9, "x" * 3000), (10, "x" * 3000 + "1" + "y" + "x" * 2999), (11, "y" + "x" * 2999), (12, "y" + "x" * 2999)]
    rows += rows[:30]
    want = brute_variants(brute_words(rows))
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[0] != v[1] and v[0] for v in want.values())
    docs = frame(spark, rows).repartition(3)
    assert by_word(spelling.grouped(docs, Work(spark, "t"))) == want
    assert spelling.grouped(frame(spark, []), Work(spark, "t")).count() == 0


@pytest.mark.parametrize("block", [2, 7, 32_768])
def test_blocks_are_cut_without_losing_pairs(spark, block):
    """Many words that begin or end alike, in blocks of any size; ties between forms; chains of forms."""
    words = {"prefix" + "".join(x): 1 + i for i, x in enumerate(itertools.product("abc", repeat=3))}
    words |= {"".join(x) + "suffix": 4 for x in itertools.product("ab", repeat=4)}
    words |= {"chain" + "x" * k: 3 << k for k in range(12)}
    words |= {"".join(RNG.choice("ab") for _ in range(RNG.randrange(5, 9))): RNG.randrange(3, 9) for _ in range(150)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    want = brute_variants(words)
    assert by_word(spelling.variants(table, Work(spark, "t"), block)) == want
    assert want["chainx"][1] == "chain" + "x" * 11
    sizes = spelling.blocks(table, Work(spark, "t"), block).groupBy("q", "a", "b", "key").count().where("b - a > 1").agg(F.max("count")).first()[0]
    assert sizes is None or sizes <= block


def test_wavelet_against_brute_force():
    for n in (1, 2, 3, 17, 200):
        values = np.random.default_rng(n).permutation(n)
        tree = spelling.Wavelet(values)
        bounds = np.random.default_rng(n + 1).integers(0, n + 1, (4, 50))
        query, value = tree.report(*bounds)
        want = {(k, int(v)) for k, (i, j, lo, hi) in enumerate(bounds.T) for v in values[i:j] if lo <= v < hi}
        assert set(zip(query.tolist(), value.tolist(), strict=True)) == want and len(query) == len(want)


def test_spelling_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    words = brute_words(rows)
    got = by_word(queries.op13_spelling(spark, d))
    assert {w: v[2] for w, v in got.items()} == words
    deleted = defaultdict(set)  # one edit apart by deletions, another way than the operator's
    for w in words:
        for i in range(len(w)):
            deleted[len(w), i, w[:i] + "\0" + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in deleted.values():
        for a, b in itertools.permutations(group, 2):
            near[a].add(b)
    for w in words:
        for i in range(len(w)):
            if (u := w[:i] + w[i + 1 :]) in words:
                near[w].add(u)
                near[u].add(w)
    assert {w: v[3] for w, v in got.items()} == {w: len(near[w]) for w in words}


def test_fast_encoder_gives_the_library_s_ids(tmp_path):
    """On strings of any kind; and it isn't used where the ids don't follow the merges."""
    import json

    from codexloom.llm.vocab import Vocabulary

    path = P.path("byte_bpe_50k.json")
    words = Vocabulary(path, "blank")
    assert words.fast is not None
    signs = "aab-=_ésß中😀.\\n\\t'!0123456789TtHhEe sdrm"
    texts = ["".join(RNG.choice(signs) for _ in range(RNG.randrange(1, 60))) for _ in range(4000)]
    texts += [c * k for c in "a-=_ \\n0!." for k in range(1, 40)] + ["<|endoftext|> x <|endoftext|>", ""]
    words.tokenizer.encode_special_tokens = True
    want = [e.ids for e in words.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [words.fast.encode_ordinary(t) for t in texts] == want
    assert [np.frombuffer(x, words.dtype).tolist() for x in words.encode(texts)] == want
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    first, second = model["model"]["merges"][500:502]
    model["model"]["merges"][500:502] = [second, first]
    (tmp_path / "other.json").write_text(json.dumps(model), encoding="utf-8")
    assert Vocabulary(str(tmp_path / "other.json"), "blank").fast is None
